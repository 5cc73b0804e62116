"""Queries on demand, scenarios, exponents and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgrid.functions import curves
from flowgrid.functions.storage import fresh_path, materialize
from flowgrid.operators import centrality, demand, fits, gravity, nonlinear, slices, tiling
from flowgrid.plans.catalogue import query
from flowgrid.plans.flows import pairs
from flowgrid.plans.tiling import LOCATED, located
from flowgrid.plans.trips import DECIDED, RUN, curve, decisions, rounded, unload
from flowgrid.plans.views import table, view
from flowgrid.streaming import streams


def od(spark, d):
    return view(spark, d, "tij").withColumnRenamed("number_people", "n")


@query("d01_scale_od", "SELECT origin, destination, cast(number_people * 3600 * 5 // (SELECT sum(number_people) FROM tij) AS BIGINT) AS n FROM tij")
def d01(spark, d):
    return demand.scale_od(od(spark, d), F.lit(5))


ODX = "SELECT *, sum(n) OVER (ORDER BY origin, destination ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT origin, destination, number_people AS n FROM tij)"
PERSONS = f"SELECT cast(coalesce(b, 0) + pos AS BIGINT) AS person, origin, destination, pos, 25200 + pos * 3600 / n AS departure FROM (SELECT *, unnest(range(n)) AS pos FROM ({ODX}))"


def persons(spark, d):
    return demand.expand_persons(od(spark, d), F.lit(7))


for _n in ("d02_persons", "w06_person_ids"):
    query(_n, f"SELECT person, origin, destination, pos, round(departure, 6) AS departure FROM ({PERSONS})")(lambda spark, d: rounded(persons(spark, d)))


@query("t02_sort_demand", f"SELECT person, round(departure, 6) AS departure FROM ({PERSONS}) ORDER BY departure, person")
def t02(spark, d):
    return rounded(persons(spark, d).select("person", "departure")).orderBy("departure", "person")


MEMBERS = f"SELECT cell, list(index ORDER BY index) AS nodes, len(list(index)) AS m FROM ({LOCATED}) WHERE cell IS NOT NULL GROUP BY cell"
ASSIGNED = f"SELECT person, origin, destination, a.nodes[cast((origin * 7919 + destination * 104729 + pos * 1299709 + 11) % a.m AS INT) + 1] AS origin_node, b.nodes[cast((origin * 7919 + destination * 104729 + pos * 1299709 + 341) % b.m AS INT) + 1] AS destination_node FROM ({PERSONS}) p LEFT JOIN ({MEMBERS}) a ON a.cell = origin LEFT JOIN ({MEMBERS}) b ON b.cell = destination"


def assigned(spark, d):
    members = located(spark, d).filter("cell is not null").select("cell", F.col("index").alias("node"))
    return demand.assign_nodes(persons(spark, d), members)


@query("d03_assign_nodes", f"SELECT person, origin_node, destination_node FROM ({ASSIGNED})")
def d03(spark, d):
    return assigned(spark, d).select("person", "origin_node", "destination_node")


@query("a29_kept_lost", f"SELECT count(*) FILTER (origin_node IS NOT NULL AND destination_node IS NOT NULL) AS kept, count(*) FILTER (origin_node IS NULL OR destination_node IS NULL) AS lost FROM ({ASSIGNED})")
def a29(spark, d):
    return demand.kept_lost(assigned(spark, d)).select("kept", "lost")


HOURS = "SELECT hour, origin, destination, number_people + (origin + destination + hour) % 3 AS n FROM tij CROSS JOIN (SELECT unnest([6, 7, 8])::BIGINT AS hour) h"


def hours(spark, d):
    h = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (6, 7, 8)]))
    return view(spark, d, "tij").withColumn("hour", h).select("hour", "origin", "destination", (F.col("number_people") + (F.col("origin") + F.col("destination") + F.col("hour")) % 3).alias("n"))


SCALED = f"SELECT hour, origin, destination, cast(n * 3600 * CASE WHEN hour = 7 THEN 4 ELSE cast(floor(s / 3600) AS BIGINT) END // s AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY hour) AS s FROM ({HOURS}))"
DAY = f"SELECT hour, cast(coalesce(b, 0) + pos AS BIGINT) AS person, origin, destination, round(hour * 3600 + pos * 3600 / n, 6) AS departure FROM (SELECT *, unnest(range(n)) AS pos FROM (SELECT *, sum(n) OVER (ORDER BY hour, origin, destination ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({SCALED})))"


def day(spark, d):
    return demand.day_demand(hours(spark, d), 7, 4)


for _n in ("d04_day_demand", "u01_union_hours"):
    query(_n, DAY)(lambda spark, d: rounded(day(spark, d).select("hour", "person", "origin", "destination", "departure")))


@query("a25_departures", f"SELECT cast(floor(departure / 3600) AS BIGINT) AS hour, count(*) AS n FROM ({DAY}) GROUP BY 1")
def a25(spark, d):
    return demand.departures(day(spark, d))


@query("d05_scenario_grid", "SELECT uci10, 100 + 20 * unnest(range(10)) AS r FROM (SELECT DISTINCT uci10 FROM runs)")
def d05(spark, d):
    return demand.rate_grid(100, 300, 10, view(spark, d, "runs").select("uci10").distinct())


def city(spark, d):
    return tiling.with_roads(view(spark, d, "cells"), located(spark, d))


def scenarios(spark, d, n=12, k=3):
    """n scenarios of k centers for each of the table's segments."""
    base = view(spark, d, "runs").select("uci10").distinct()
    return base.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("center", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select((F.col("uci10") * 100 + F.col("s")).alias("scenario"), "center")


@query("d06_draw_centers")
def d06(spark, d):
    return demand.draw_centers(city(spark, d), scenarios(spark, d), 5)


@query("d07_spread")
def d07(spark, d):
    return demand.spread(demand.draw_centers(city(spark, d), scenarios(spark, d), 5), 5, isotropic=False)


def given_population(spark, d):
    c = view(spark, d, "cells")
    centers = c.filter("idx % 7 = 0").select((F.col("idx") % 2).alias("scenario"), F.col("idx").alias("center"), "cx", "cy", F.lit(2.0).alias("sx"), F.lit(2.0).alias("sy"))
    return demand.synth_population(c.withColumn("with_roads", F.lit(True)), centers, "exponential", 100000.0)


HV = "2 * 6371.0088::double * asin(sqrt(pow(sin(radians({3} - ({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - ({0})) / 2), 2)))"
GIVEN = f"SELECT scenario, idx, b * 100000 / sum(b) OVER (PARTITION BY scenario) AS population FROM (SELECT g.idx % 2 AS scenario, c.idx, sum(exp(-sqrt(pow({HV.format('g.cx', 'g.cy', 'c.cx', 'g.cy')}, 2) + pow({HV.format('g.cx', 'g.cy', 'g.cx', 'c.cy')}, 2)) / 2)) / 2 + 1e-6 AS b FROM cells g CROSS JOIN cells c WHERE g.idx % 7 = 0 GROUP BY 1, 2)"


@query("d08_synth_population", f"SELECT scenario, idx, round(population, 4) AS population FROM ({GIVEN})")
def d08(spark, d):
    return rounded(given_population(spark, d).select("scenario", "idx", "population"), 4)


def block_of_cities(spark, d, block, n=12, k=3):
    """uci of n more scenarios of each kind for every segment of the table; ``block`` numbers them and seeds their draws."""
    some = scenarios(spark, d, n, k).withColumn("scenario", F.col("scenario") * 1000 + block)
    out = None
    for kind in ("gaussian", "exponential"):
        own = some.withColumn("scenario", F.concat(F.lit(f"{kind}-"), F.lpad(F.col("scenario").cast("string"), 12, "0")))
        centers = demand.spread(demand.draw_centers(city(spark, d), own, 5 + block), 5 + block)
        rows = centrality.uci(pairs(spark, d), demand.synth_population(city(spark, d), centers, kind, 100000.0), "population", ["scenario"]).select("scenario", "uci")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("d09_scenario_search")
def d09(spark, d):
    return demand.scenario_search(lambda block: block_of_cities(spark, d, block))


@query("d10_scenario_flows", f"SELECT scenario, origin, destination, round(raw * 10000 / sum(raw) OVER (PARTITION BY scenario), 4) AS people FROM (SELECT a.scenario, z.i AS origin, z.j AS destination, CASE WHEN floor(a.population) = 0 OR floor(b.population) = 0 OR exp(distance * -0.1::double) <= 1e-4 THEN 0 ELSE 0.5 * pow(a.population, 0.9::double) * pow(b.population, 0.7::double) * exp(distance * -0.1::double) END AS raw FROM pairs z JOIN ({GIVEN}) a ON a.idx = z.i JOIN ({GIVEN}) b ON b.idx = z.j AND b.scenario = a.scenario)")
def d10(spark, d):
    return rounded(gravity.gravity_flows(given_population(spark, d), pairs(spark, d), 0.5, 0.9, 0.7, -0.1, 10000.0, ["scenario"]), 4)


COVER = "SELECT c_custkey AS scenario, abs(c_acctbal) / 10000 AS uci FROM customer"


def acct(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("scenario"), (F.abs("c_acctbal") / F.lit(10000.0)).alias("uci"))


for _n in ("a30_uci_coverage", "w10_top_per_bucket"):
    query(_n, f"SELECT scenario, cast(floor(round(uci / 0.1::double, 9)) AS BIGINT) AS bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY floor(round(uci / 0.1::double, 9)) ORDER BY scenario) AS place FROM ({COVER})) WHERE place <= 4")(
        lambda spark, d: demand.uci_coverage(acct(spark, d)).select("scenario", "bucket", "place"))


@query("s09_scenario_population")
def s09(spark, d):
    from flowgrid.sources import files

    path = fresh_path(spark, "grids")
    for s in (0, 1):
        given_population(spark, d).filter(F.col("scenario") == s).drop("scenario").write.parquet(f"{path}/Grid_0.{s + 1}.parquet")
    return files.read_scenario_population(spark, path)


@query("s12_write_demand")
def s12(spark, d):
    from flowgrid.sources import files

    path = fresh_path(spark, "demand")
    files.write_demand(persons(spark, d).withColumns({"uci10": F.col("origin") % 5 + 1, "r": F.lit(100)}), path)
    return spark.read.option("header", True).schema("person long, origin long, destination long, pos long, departure double, uci10 long, r long").csv(path)


@query("f05_fitted_curve", """SELECT uci10, r, t0, i, round(n, 6) AS n, round(v * max(CASE WHEN i = 4 THEN n END) OVER w / max(CASE WHEN i = 4 THEN v END) OVER w, 3) AS fitted FROM (
    SELECT uci10, r, t0, c.i, c.n, CASE WHEN err_pl <= err_exp THEN a_pl * pow(x, alpha_pl) ELSE a_exp * exp(alpha_exp * x) END AS v FROM (SELECT *, t - max(CASE WHEN i = 3 THEN t END) OVER (PARTITION BY uci10, r) AS x FROM curve) c JOIN (SELECT * EXCLUDE (n, t) FROM fits) f USING (uci10, r) WHERE c.i >= 4 AND c.i < t0) WINDOW w AS (PARTITION BY uci10, r, t0)""")
def f05(spark, d):
    c = curve(spark, d)
    out = fits.fitted_curve(c, fits.expanding_fits(c, RUN), RUN)
    return out.select(*RUN, "t0", "i", F.round("n", 6).alias("n"), F.round("fitted", 3).alias("fitted"))


CRITICAL = f"SELECT uci10, min(r) FILTER (verdict = 'jam') AS r_critical FROM ({DECIDED}) GROUP BY uci10"


def critical_rates(spark, d, curve=None):
    """The least rate of a jammed run for each uci; where no run is jammed nothing is critical."""
    return decisions(spark, d, curve).groupBy("uci10").agg(F.min(F.when(F.col("verdict") == "jam", F.col("r"))).alias("r_critical"))


BETA = f"SELECT uci10, k, count(*) AS n, regr_slope(y, x) AS beta, sqrt(greatest((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0)) / count(*), 0)) AS error FROM (SELECT u.uci10, k, ln((r * r - r_critical * r_critical) / (r_critical * r_critical)::double) AS x, ln(n_rows) AS y FROM unload u JOIN ({CRITICAL}) z ON z.uci10 = u.uci10 WHERE r > r_critical AND n_rows > 0) GROUP BY uci10, k HAVING count(*) > 1"


def betas(spark, d):
    stored = materialize(unload(spark, d), "unload")
    return fits.beta(stored, critical_rates(spark, d, stored).filter("r_critical is not null"))


@query("f06_beta", f"SELECT uci10, k, n, round(beta, 5) AS beta, round(error, 5) AS error FROM ({BETA})")
def f06(spark, d):
    return rounded(betas(spark, d), 5)


@query("t05_best_beta", f"SELECT uci10, arg_min(k, round(error, 9)) AS k, round(arg_min(beta, round(error, 9)), 5) AS beta FROM ({BETA}) WHERE n > 2 GROUP BY uci10")
def t05(spark, d):
    # two points always fit exactly
    order = F.struct(F.round("error", 9), "k")
    return betas(spark, d).filter("n > 2").groupBy("uci10").agg(F.min_by("k", order).alias("k"), F.round(F.min_by("beta", order), 5).alias("beta"))


@query("f11_nonlinear_fit")
def f11(spark, d):
    """Both decays of every run's curve from seven on, in raw space over its sum; bins without arrivals count."""
    points = unload(spark, d).filter("k >= 28").select((F.col("uci10") * 1000 + F.col("r")).alias("series"), ((F.col("k") - 27) / F.lit(4.0)).alias("x"), F.col("n_rows").alias("y"))
    return rounded(nonlinear.fit_curves(points, ["power", "exponential"]).drop("loss", "rounds"), 6)


@query("f15_scaling_collapse", f"""SELECT u.uci10, u.r, k, round((floor(k * 86400 / 95.0) / 3600 - 7) * (u.r * u.r - r_critical * r_critical) / (r_critical * r_critical), 6) AS x, round(n_rows * pow(floor(k * 86400 / 95.0) / 3600, -alpha), 4) AS y
    FROM unload u JOIN ({CRITICAL}) z ON z.uci10 = u.uci10 JOIN (SELECT uci10, r, alpha FROM ({DECIDED})) c ON c.uci10 = z.uci10 AND c.r = z.r_critical WHERE n_rows > 0""")
def f15(spark, d):
    """Time and number of rows scaled by the distance from the critical rate and by the critical run's exponent."""
    stored = materialize(unload(spark, d), "unload")
    runs = materialize(decisions(spark, d, stored), "decisions")
    critical = runs.filter("verdict = 'jam'").groupBy("uci10").agg(F.min_by(F.struct("r", "alpha"), "r").alias("c")).select("uci10", F.col("c.r").alias("r_critical"), F.col("c.alpha").alias("alpha"))
    t = slices.bin_start(F.col("k")) / F.lit(3600.0)
    rows = stored.filter("n_rows > 0").join(critical, "uci10")
    e = curves.epsilon(F.col("r").cast("double"), F.col("r_critical").cast("double"))
    return rows.select(*RUN, "k", F.round((t - 7) * e, 6).alias("x"), F.round(F.col("n_rows") * F.pow(t, -F.col("alpha")), 4).alias("y"))


@query("m17_epsilon", f"SELECT DISTINCT uci10, r, round((r * r - r_critical * r_critical) / (r_critical * r_critical)::double, 9) AS epsilon FROM runs JOIN ({CRITICAL}) z USING (uci10)")
def m17(spark, d):
    rows = view(spark, d, "runs").select(*RUN).distinct().join(critical_rates(spark, d), "uci10")
    return rounded(rows.select(*RUN, curves.epsilon(F.col("r").cast("double"), F.col("r_critical").cast("double")).alias("epsilon")), 9)


@query("f16_windowed_alpha", """WITH pts AS (SELECT uci10, r, k, (k - 27) / 4.0::double AS x, ln(n_rows) AS y FROM unload WHERE k >= 28 AND n_rows > 0),
    f AS (SELECT p.uci10, p.r, e.k AS end_k, regr_slope(y, x) AS alpha, sqrt(greatest((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*), 0)) AS err FROM pts p JOIN (SELECT uci10, r, k FROM pts WHERE k >= 31) e ON e.uci10 = p.uci10 AND e.r = p.r AND p.k <= e.k GROUP BY ALL HAVING count(*) >= 4)
    SELECT uci10, r, arg_min(end_k, round(err, 12)) AS k, round(arg_min(alpha, round(err, 12)), 5) AS alpha, round(min(err), 6) AS error FROM f GROUP BY uci10, r""")
def f16(spark, d):
    out = fits.windowed_alpha(unload(spark, d), RUN)
    return out.select(*RUN, "k", F.round("alpha", 5).alias("alpha"), F.round("error", 6).alias("error"))


@query("f18_dp_exponents", f"SELECT uci10, r, round(alpha, 5) AS alpha, dimension FROM (SELECT x.*, dimension, row_number() OVER (PARTITION BY uci10, r ORDER BY round(abs(-alpha - beta / nu), 9), dimension) AS p FROM ({DECIDED}) x CROSS JOIN (VALUES ('1', 0.276486::double, 1.733847::double), ('2', 0.584, 1.295), ('3', 0.81, 1.105), ('mean field', 1.0, 1.0)) t(dimension, beta, nu) WHERE verdict = 'jam') WHERE p = 1")
def f18(spark, d):
    return fits.dp_exponents(decisions(spark, d)).select(*RUN, F.round("alpha", 5).alias("alpha"), "dimension")


@query("m18_curve_json")
def m18(spark, d):
    f = fits.expanding_fits(curve(spark, d), RUN)
    text = f.groupBy(*RUN).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("string"), F.struct("alpha_pl", "alpha_exp"))))).alias("json"))
    parsed = text.select(*RUN, F.explode(F.from_json("json", "map<string, struct<alpha_pl: double, alpha_exp: double>>")).alias("t", "fit"))
    return parsed.select(*RUN, F.col("t").cast("double").alias("t"), "fit.alpha_pl", "fit.alpha_exp")


@query("m02_first_of_list", """SELECT uniqueid, array_to_string(list_transform(CASE WHEN starts_with(maxspeed, '[') THEN string_split(trim(maxspeed, '[]'), ', ') ELSE [maxspeed] END, lambda x: trim(x, '"')), '|') AS items,
    trim(CASE WHEN starts_with(maxspeed, '[') THEN string_split(trim(maxspeed, '[]'), ', ')[1] ELSE maxspeed END, '"') AS first FROM raw_roads""")
def m02(spark, d):
    from flowgrid.operators.roads import first_of_list

    items = first_of_list(F.col("maxspeed"))
    return view(spark, d, "raw_roads").select("uniqueid", F.array_join(items, "|").alias("items"), F.try_element_at(items, F.lit(1)).alias("first"))


# A window's row comes when the watermark, an hour behind the last event, has passed its end.
PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def closed(spark, stream, name):
    """What the stream has stored, with times as the oracles have them."""
    out = streams.run_to_table(stream, name)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "end") else F.round(c, 6).alias(c) if c == "speed" else F.col(c) for c in out.columns])


@query("x01_unload_stream", f"SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 15 MINUTES, any_value(ts)) + INTERVAL 15 MINUTES <= {PASSED}")
def x01(spark, d):
    return closed(spark, streams.unload_stream(streams.events(spark, d)), "unload")


@query("x02_edge_load_stream", f"SELECT start, edge, count(*) AS flux, round(avg(value), 6) AS speed FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(5 * unnest(range(3))) AS start, event_type AS edge, value FROM events) GROUP BY start, edge HAVING start + INTERVAL 15 MINUTES <= {PASSED}")
def x02(spark, d):
    return closed(spark, streams.edge_load_stream(streams.events(spark, d)), "edge-load")


@query("x03_trip_sessions", f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS pings FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trip
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, trip HAVING max(ts) + INTERVAL 30 MINUTES <= {PASSED}""")
def x03(spark, d):
    return closed(spark, streams.trip_sessions(streams.events(spark, d)), "sessions")
