"""Queries on raw roads and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgrid.operators import roads, trajectory
from flowgrid.plans.catalogue import query
from flowgrid.plans.trips import rounded
from flowgrid.plans.views import table, view


# What the oracles know of the classes that raw_roads has: stated apart from the operators' tables.
LANES_OF = "CASE highway WHEN 'motorway' THEN 4 WHEN 'trunk' THEN 3 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 2 WHEN 'unclassified' THEN 2 WHEN 'road' THEN 1 WHEN 'motorway_link' THEN 1 WHEN 'trunk_link' THEN 1 WHEN 'primary_link' THEN 1 WHEN 'secondary_link' THEN 1 WHEN 'tertiary_link' THEN 1 END"
MPH_OF = "CASE WHEN highway LIKE 'motorway%' THEN CASE WHEN least(lanes, 4) <= 2 THEN 50 ELSE 65 END WHEN highway LIKE 'trunk%' THEN 45 WHEN highway LIKE 'primary%' OR highway = 'road' THEN 30 WHEN highway LIKE 'secondary%' THEN 25 WHEN highway LIKE 'tertiary%' OR highway = 'unclassified' THEN 20 END"
LANE_FLOW = "CASE WHEN highway LIKE 'motorway%' THEN CASE least(lanes, 4) WHEN 1 THEN 1900 WHEN 4 THEN 2200 ELSE 2000 END WHEN highway LIKE 'trunk%' THEN CASE lanes WHEN 1 THEN 1900 ELSE 2000 END WHEN highway LIKE 'primary%' THEN 1000 WHEN highway LIKE 'secondary%' OR highway LIKE 'tertiary%' OR highway = 'road' THEN 900 WHEN highway = 'unclassified' THEN 800 END"
US_FLOW = "coalesce(CASE {0} WHEN 'motorway' THEN 2000 WHEN 'motorway_link' THEN 1800 WHEN 'trunk' THEN 1800 WHEN 'trunk_link' THEN 1600 WHEN 'primary' THEN 1600 WHEN 'primary_link' THEN 1400 WHEN 'secondary' THEN 1400 WHEN 'secondary_link' THEN 1200 WHEN 'tertiary' THEN 1200 WHEN 'tertiary_link' THEN 1000 WHEN 'unclassified' THEN 800 WHEN 'living_street' THEN 300 WHEN 'service' THEN 400 WHEN 'road' THEN 1000 END, 0)"
ITEMS = "list_filter(regexp_split_to_array(translate({0}, '[]\"''', ''), '\\s*[,;|]\\s*'), lambda x: trim(x) <> '')"
NUMBER = "try_cast(nullif(regexp_extract({0}, '^\\s*(\\d+)', 1), '') AS DOUBLE)"
SPEEDS = f"list_filter(list_transform({ITEMS.format('maxspeed')}, lambda x: {NUMBER.format('x')}), lambda x: x IS NOT NULL)"
MAXSPEED = f"CASE WHEN maxspeed IS NOT NULL THEN coalesce(list_avg({SPEEDS}), 10) END"
MPH = f"coalesce(cast({NUMBER.format(ITEMS.format('maxspeed') + '[1]')} AS BIGINT), 0)"
LANES = f"CASE WHEN starts_with(lanes, '[') THEN cast(floor(list_avg(list_transform(list_filter({ITEMS.format('lanes')}, lambda x: regexp_full_match(trim(x), '\\d')), lambda x: cast(trim(x) AS DOUBLE)))) AS BIGINT) ELSE cast({NUMBER.format('lanes')} AS BIGINT) END"
LANES_FIRST = "coalesce(cast(" + NUMBER.format("translate(lanes, '[]\"''', '')") + " AS BIGINT), 0)"


def raw(spark, d):
    return view(spark, d, "raw_roads")


def parsed(spark, d):
    """Raw roads with class, lanes and limit as values."""
    r = raw(spark, d)
    return r.select("uniqueid", "u", "v", "oneway", "highway", roads.parse_lanes(F.col("lanes")).alias("lanes"), roads.parse_maxspeed(F.col("maxspeed")).alias("maxspeed"))


PARSED = f"SELECT uniqueid, u, v, oneway, highway, {LANES} AS lanes, {MAXSPEED} AS maxspeed FROM raw_roads"
IMPUTED = f"SELECT * REPLACE (coalesce(lanes, {LANES_OF}, 1) AS lanes) FROM ({PARSED})"
ALLOCATED = f"SELECT * REPLACE (greatest(CASE WHEN oneway THEN lanes ELSE lanes // 2 END, 1) AS lanes) FROM ({IMPUTED})"


@query("p07_maxspeed", f"SELECT uniqueid, round({MAXSPEED}, 6) AS maxspeed FROM raw_roads")
def p07(spark, d):
    return rounded(parsed(spark, d).select("uniqueid", "maxspeed"))


@query("p08_maxspeed_first", f"SELECT uniqueid, {MPH} AS mph, round(CASE WHEN {MPH} = 0 THEN 35 ELSE {MPH} END * 1.60934::double, 6) AS kmh FROM raw_roads")
def p08(spark, d):
    return rounded(raw(spark, d).select("uniqueid", roads.parse_maxspeed_first(F.col("maxspeed")).alias("mph"), roads.speed_limit_kmh(F.col("maxspeed")).alias("kmh")))


@query("p09_lanes", f"SELECT uniqueid, {LANES} AS lanes FROM raw_roads")
def p09(spark, d):
    return parsed(spark, d).select("uniqueid", "lanes")


@query("p10_lanes_first", f"SELECT uniqueid, {LANES_FIRST} AS lanes FROM raw_roads")
def p10(spark, d):
    return raw(spark, d).select("uniqueid", roads.parse_lanes_first(F.col("lanes")).alias("lanes"))


@query("p11_collapse_highway", "SELECT uniqueid, CASE WHEN uniqueid % 3 = 0 OR uniqueid % 3 = 1 AND highway IN ('service', 'living_street') THEN 'footway' ELSE highway END AS highway FROM raw_roads")
def p11(spark, d):
    text = F.expr("case uniqueid % 3 when 0 then '[\"footway\", \"path\"]' when 1 then concat('[\"footway\", \"', highway, '\"]') else highway end")
    return raw(spark, d).select("uniqueid", roads.collapse_highway(text).alias("highway"))


@query("p12_impute_lanes", f"SELECT i.uniqueid, i.lanes, coalesce(p.lanes, cast(floor(m) AS BIGINT), 1) AS lanes_median FROM ({IMPUTED}) i JOIN ({PARSED}) p USING (uniqueid) JOIN (SELECT highway, quantile_cont(lanes, 0.5) AS m FROM ({PARSED}) GROUP BY highway) q ON q.highway = i.highway")
def p12(spark, d):
    p = parsed(spark, d)
    return roads.impute_lanes(p).select("uniqueid", "lanes").join(roads.impute_lanes(p, "median").select("uniqueid", F.col("lanes").alias("lanes_median")), "uniqueid")


@query("p13_allocate_lanes", f"SELECT uniqueid, lanes, least(lanes, 4) AS lanes_capped FROM ({ALLOCATED})")
def p13(spark, d):
    return roads.allocate_lanes(roads.impute_lanes(parsed(spark, d))).select("uniqueid", "lanes", "lanes_capped")


@query("p14_infer_speed", f"SELECT uniqueid, round(coalesce(maxspeed, {MPH_OF}), 6) AS speed_mph FROM ({ALLOCATED})")
def p14(spark, d):
    return rounded(roads.infer_speed(roads.allocate_lanes(roads.impute_lanes(parsed(spark, d)))).select("uniqueid", "speed_mph"))


@query("p15_infer_capacity", f"SELECT uniqueid, cast({LANE_FLOW} * lanes AS DOUBLE) AS capacity FROM ({ALLOCATED})")
def p15(spark, d):
    return roads.infer_capacity(roads.allocate_lanes(roads.impute_lanes(parsed(spark, d)))).select("uniqueid", "capacity")


@query("p16_capacity_us", f"SELECT uniqueid, cast({US_FLOW.format('h')} * lanes AS DOUBLE) AS capacity FROM (SELECT *, CASE WHEN uniqueid % 7 = 0 THEN 'corridor' ELSE highway END AS h FROM ({IMPUTED}))")
def p16(spark, d):
    r = roads.impute_lanes(parsed(spark, d)).withColumn("highway", F.expr("case when uniqueid % 7 = 0 then 'corridor' else highway end"))
    return roads.capacity_us(r).select("uniqueid", "capacity")


@query("p17_clean_edges", f"SELECT uniqueid, u, v, highway, {LANES_FIRST} AS lanes, round(CASE WHEN {MPH} = 0 THEN 35 ELSE {MPH} END * 1.60934::double, 6) AS speed_kmh, cast({US_FLOW.format('highway')} * {LANES_FIRST} AS DOUBLE) AS capacity FROM raw_roads")
def p17(spark, d):
    return rounded(roads.clean_edges(raw(spark, d)))


for _n in ("p18_distinct_classes", "u04_distinct"):
    query(_n, "SELECT DISTINCT highway FROM raw_roads")(lambda spark, d: raw(spark, d).select(roads.collapse_highway(F.col("highway")).alias("highway")).distinct())


@query("p19_major_roads", "SELECT index FROM nodes WHERE index IN (SELECT u FROM raw_roads WHERE highway NOT IN ('service', 'living_street') UNION SELECT v FROM raw_roads WHERE highway NOT IN ('service', 'living_street'))")
def p19(spark, d):
    return roads.nodes_of(view(spark, d, "nodes"), roads.major_roads(raw(spark, d))).select("index")


@query("p20_densify_ids", "WITH ids AS MATERIALIZED (SELECT old, row_number() OVER (ORDER BY old) - 1 AS id FROM (SELECT u AS old FROM edges UNION SELECT v FROM edges) z) SELECT e.uniqueid, a.id AS u_id, b.id AS v_id FROM edges e JOIN ids a ON a.old = e.u JOIN ids b ON b.old = e.v".replace("ids AS MATERIALIZED", "dense AS").replace("JOIN ids", "JOIN dense"))
def p20(spark, d):
    return roads.densify_ids(view(spark, d, "edges")).select("uniqueid", "u_id", "v_id")


@query("p21_map_endpoints", "SELECT e.uniqueid, a.osmid AS u, b.osmid AS v FROM edges e JOIN nodes a ON a.index = e.u JOIN nodes b ON b.index = e.v")
def p21(spark, d):
    return roads.map_endpoints(view(spark, d, "edges"), view(spark, d, "nodes")).select("uniqueid", "u", "v")


@query("p22_inhabited", "SELECT idx, population, population > 300 AS is_populated FROM cells WHERE population > 0")
def p22(spark, d):
    return view(spark, d, "cells").filter("population > 0").select("idx", "population", (F.col("population") > 300).alias("is_populated"))


@query("p23_inside_edge", "SELECT idx, position = 'inside' AND population > 0 AS inside, relation_to_line = 'edge' AS edge FROM cells")
def p23(spark, d):
    return view(spark, d, "cells").select("idx", F.expr("position = 'inside' and population > 0").alias("inside"), F.expr("relation_to_line = 'edge'").alias("edge"))


for _n in ("p24_restrict_pairs", "j15_semi_join"):
    query(_n, "SELECT origin, destination FROM tij WHERE origin IN (SELECT idx FROM cells WHERE population > 300) AND destination IN (SELECT idx FROM cells WHERE population > 300)")(
        lambda spark, d: roads.restrict_pairs(view(spark, d, "tij"), view(spark, d, "cells").filter("population > 300"), "origin", "destination").select("origin", "destination"))


@query("p26_percentile_band", "SELECT origin, destination, number_people FROM tij WHERE number_people >= (SELECT quantile_cont(number_people, 0.1) FROM tij) AND number_people <= (SELECT quantile_cont(number_people, 0.9) FROM tij)")
def p26(spark, d):
    return roads.percentile_band(view(spark, d, "tij"), "number_people", 0.1, 0.9)


@query("p28_bbox", "SELECT index FROM nodes WHERE x BETWEEN -71.19 AND -71.15 AND y BETWEEN 42.2 AND 42.25")
def p28(spark, d):
    return roads.bbox(view(spark, d, "nodes"), "x", "y", (-71.19, 42.2, -71.15, 42.25)).select("index")


P29_SQL = """SELECT 'origin' AS kind, origin AS cell, count(*) AS n, cast(sum(number_people) AS BIGINT) AS people FROM tij GROUP BY origin
    UNION ALL SELECT 'destination', destination, count(*), cast(sum(number_people) AS BIGINT) FROM tij GROUP BY destination
    UNION ALL SELECT 'cell', idx, count(*), cast(sum(number_people) AS BIGINT) FROM cells JOIN tij ON origin = idx OR destination = idx GROUP BY idx"""


@query("p29_subsample", P29_SQL)
def p29(spark, d):
    return roads.subsample(view(spark, d, "tij")).groupBy("kind", "cell").agg(F.count("*").alias("n"), F.sum("number_people").alias("people"))


@query("s01_read_trips", "SELECT p, time_departure, distance FROM people")
def s01(spark, d):
    from flowgrid.sources import files

    return files.stored_and_read(view(spark, d, "people"), files.write_trips, files.read_trips).select("p", "time_departure", "distance")


@query("s02_read_routes", "SELECT p, pos, route FROM routes")
def s02(spark, d):
    from flowgrid.sources import files

    parts = view(spark, d, "routes").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("pos", "route"))).alias("x"))
    text = parts.select("p", F.lit(0.0).alias("distance"), F.concat(F.lit("["), F.array_join(F.col("x.route").cast("array<string>"), ","), F.lit(",]")).alias("route"))
    out = trajectory.explode_routes(files.stored_and_read(text, files.write_routes, files.read_routes))
    return out.select("p", F.col("pos").cast("bigint").alias("pos"), "route")


@query("s03_read_network", "SELECT uniqueid, u, v, length, speed_mph, lanes FROM edges")
def s03(spark, d):
    from flowgrid.sources import files

    return files.stored_and_read(view(spark, d, "edges").select("uniqueid", "u", "v", "length", "speed_mph", "lanes"), files.write_edges, files.read_edges)


@query("s03_read_nodes", "SELECT e.uniqueid, a.osmid AS osmid_u, round(a.x, 6) AS x_u, round(a.y, 6) AS y_u FROM edges e JOIN nodes a ON a.index = e.u")
def s03_nodes(spark, d):
    from flowgrid.functions.storage import fresh_path
    from flowgrid.sources import files

    folder = fresh_path(spark, "network")
    files.write_nodes(view(spark, d, "nodes"), f"{folder}/nodes.csv")
    files.write_edges(view(spark, d, "edges").select("uniqueid", "u", "v", "length", "speed_mph", "lanes"), f"{folder}/edges.csv")
    nodes, edges = files.read_network(spark, folder)
    return rounded(edges.join(nodes.select(F.col("index").alias("u"), F.col("osmid").alias("osmid_u"), F.col("x").alias("x_u"), F.col("y").alias("y_u")), "u").select("uniqueid", "osmid_u", "x_u", "y_u"))


@query("s04_read_od_text", "SELECT origin, destination, number_people FROM tij")
def s04(spark, d):
    from flowgrid.sources import files

    return files.stored_and_read(view(spark, d, "tij"), files.write_od_text, files.read_od_text).select("origin", "destination", "number_people")


@query("s05_read_od_by_hour", "SELECT origin % 24 AS hour, origin, destination, number_people FROM tij")
def s05(spark, d):
    from flowgrid.sources import files

    return files.stored_and_read(view(spark, d, "tij"), files.write_od_by_hour, files.read_od_by_hour).select("hour", "origin", "destination", "number_people")


@query("s06_run_catalog", "SELECT DISTINCT uci10 / 10.0::double AS uci, r, 7::BIGINT AS start_hour, 8::BIGINT AS end_hour, 'R_' || r || '_UCI_' || (uci10 / 10.0) || '_0_people7to8.csv' AS people_file, 'R_' || r || '_UCI_' || (uci10 / 10.0) || '_0_route7to8.csv' AS route_file FROM runs")
def s06(spark, d):
    from flowgrid.sources import files

    runs = view(spark, d, "runs").select("r", (F.col("uci10") / F.lit(10.0)).alias("uci")).distinct()
    name = lambda kind: F.concat(F.lit("R_"), F.col("r").cast("string"), F.lit("_UCI_"), F.col("uci").cast("string"), F.lit(f"_0_{kind}7to8.csv"))
    return files.run_catalog(runs.select(F.explode(F.array(name("people"), name("route"))).alias("path")))


@query("s13_membership", "SELECT index % 25 AS cell, index AS node FROM nodes")
def s13(spark, d):
    from flowgrid.sources import files

    members = view(spark, d, "nodes").select((F.col("index") % 25).alias("cell"), F.col("index").alias("node"))
    return files.stored_and_read(members, files.write_membership, files.read_membership)


@query("s10_compact", "SELECT p, o_custkey, time_departure, round(distance, 6) AS distance, num_steps, last_time_simulated FROM people")
def s10(spark, d):
    from flowgrid.functions.storage import fresh_path
    from flowgrid.sources import files

    source, target = fresh_path(spark, "csv"), fresh_path(spark, "parquet")
    files.write_trips(view(spark, d, "people"), source)
    files.compact(spark, source, target, files.TRIPS)
    return rounded(spark.read.parquet(target).select("p", "o_custkey", "time_departure", "distance", "num_steps", "last_time_simulated"))


@query("s11_write_run_output")
def s11(spark, d):
    from flowgrid.functions.storage import fresh_path
    from flowgrid.plans.trips import unload
    from flowgrid.sources import files

    path = fresh_path(spark, "runs")
    files.write_run_output(unload(spark, d), path)
    return spark.read.parquet(path)


@query("s14_fit_results")
def s14(spark, d):
    from flowgrid.plans.trips import RUN, curve
    from flowgrid.operators import fits
    from flowgrid.sources import files

    return files.stored_and_read(fits.expanding_fits(curve(spark, d), RUN), files.write_json, files.read_fits)
