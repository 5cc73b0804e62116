"""Queries on grids, rings, overlaps and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgrid.operators import hist, polygons, tiling, trajectory
from flowgrid.plans.catalogue import query
from flowgrid.plans.trips import rounded
from flowgrid.plans.views import view

BOX, SIZE = (-71.21, 42.19, -71.11, 42.29), 0.02
CENTER = (-71.16, 42.24)
HAV = "2 * 6371.0088::double * asin(sqrt(pow(sin(radians({3} - ({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - ({0})) / 2), 2)))"
FX, FY = "round((x + 71.21::double) / 0.02::double, 9)", "round((y - 42.19::double) / 0.02::double, 9)"
LOCATED = f"SELECT *, CASE WHEN x > -71.21 AND x < -71.11 AND y > 42.19 AND y < 42.29 AND {FX} <> floor({FX}) AND {FY} <> floor({FY}) THEN cast(floor({FX}) * 5 + floor({FY}) AS BIGINT) END AS cell FROM nodes"
GRID = "SELECT i * 5 + j AS idx, i, j, -71.21::double + i * 0.02::double AS minx, 42.19::double + j * 0.02::double AS miny, least(-71.21::double + i * 0.02::double + 0.02::double, -71.11::double) AS maxx, least(42.19::double + j * 0.02::double + 0.02::double, 42.29::double) AS maxy FROM (SELECT unnest(range(5)) AS i) a CROSS JOIN (SELECT unnest(range(5)) AS j) b"


def located(spark, d):
    return tiling.locate(view(spark, d, "nodes"), BOX, SIZE)


@query("g01_make_grid", f"SELECT c.idx, g.i, g.j, round(minx, 6) AS minx, round(miny, 6) AS miny, round((minx + maxx) / 2, 6) AS cx, round((miny + maxy) / 2, 6) AS cy FROM ({GRID}) g JOIN cells c ON c.idx = g.idx")
def g01(spark, d):
    g = tiling.make_grid(spark, BOX, SIZE).select("idx", "i", "j", "minx", "miny", "cx", "cy")
    return rounded(g.join(view(spark, d, "cells").select("idx"), "idx"))


@query("g02_locate", f"SELECT index, cell FROM ({LOCATED})")
def g02(spark, d):
    return located(spark, d).select("index", "cell")


@query("g03_outside", f"SELECT round(count(*) FILTER (cell IS NULL) / count(*), 9) AS outside FROM ({LOCATED})")
def g03(spark, d):
    return rounded(tiling.outside_share(located(spark, d)), 9)


@query("g04_with_roads", f"SELECT idx, idx IN (SELECT cell FROM ({LOCATED}) WHERE cell IS NOT NULL) AS with_roads FROM cells")
def g04(spark, d):
    return tiling.with_roads(view(spark, d, "cells"), located(spark, d)).select("idx", "with_roads")


@query("a23_node_counts", f"SELECT cell, count(*) AS n FROM ({LOCATED}) WHERE cell IS NOT NULL GROUP BY cell")
def a23(spark, d):
    return located(spark, d).filter("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))


_PAIRS = "SELECT i, j, round(distance, 6) AS distance, round(dx, 6) AS dx, round(dy, 6) AS dy FROM pairs"
for _n in ("g05_pairs", "j10_cross_join", "m06_haversine", "m09_unit_direction"):
    query(_n, _PAIRS)(lambda spark, d: rounded(tiling.cell_pairs(view(spark, d, "cells"))))

TANGENT_C = "(6e4::double * (1.85533::double - 0.006222::double * sin(radians(a.cx))))"
LATTICE = f"""SELECT a.idx AS a, b.idx AS b, CASE WHEN b.i > a.i THEN 'i' ELSE 'j' END AS way, {TANGENT_C} * cos(radians(a.cx)) * (b.cy - a.cy) AS dx, {TANGENT_C} * (b.cx - a.cx) AS dy,
    {HAV.format('a.cx', 'a.cy', 'b.cx', 'b.cy')} AS distance FROM cells a JOIN cells b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)"""


def lattice(spark, d):
    return tiling.lattice_edges(view(spark, d, "cells"))


@query("g06_lattice", f"SELECT a, b, way, round(dx, 4) AS dx, round(dy, 4) AS dy, round(distance, 6) AS distance, round(atan2(dy, dx), 6) AS angle FROM ({LATTICE})")
def g06(spark, d):
    e = lattice(spark, d)
    return e.select("a", "b", "way", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"), F.round("distance", 6).alias("distance"), F.round("angle", 6).alias("angle"))


@query("m07_tangent_xy", f"SELECT idx, round({TANGENT_C} * cos(radians(a.cx)) * (cy - 42.2::double), 4) AS x, round({TANGENT_C} * (cx - a.cx), 4) AS y FROM cells a")
def m07(spark, d):
    x, y = tiling.tangent_xy("cx", "cy", F.col("cx"), F.lit(42.2))
    return view(spark, d, "cells").select("idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("m08_cell_area", "SELECT idx, round((6e4::double * (1.85533::double - 0.006222::double * sin(radians(miny)))) * cos(radians(miny)) * (maxx - minx) * (6e4::double * (1.85533::double - 0.006222::double * sin(radians(miny)))) * (maxy - miny) / 1e6::double, 6) AS area FROM boxes")
def m08(spark, d):
    return view(spark, d, "boxes").select("idx", F.round(tiling.cell_area_km2("minx", "miny", "maxx", "maxy"), 6).alias("area"))


RINGED = f"SELECT *, CASE WHEN floor(r_km / 1.2::double) < 5 THEN cast(floor(r_km / 1.2::double) AS BIGINT) END AS ring FROM (SELECT *, round({HAV.format('-71.16::double', '42.24::double', 'cx', 'cy')}, 9) AS r_km FROM cells)"


def ringed(spark, d):
    return tiling.rings(view(spark, d, "cells"), CENTER, 6.0, 5)


@query("g07_rings", f"SELECT idx, round(r_km, 6) AS r_km, ring FROM ({RINGED})")
def g07(spark, d):
    return rounded(ringed(spark, d).select("idx", "r_km", "ring"))


@query("g08_ring_profile", f"SELECT ring, cast(sum(population) AS BIGINT) AS population, count(*) AS cells FROM ({RINGED}) GROUP BY ring")
def g08(spark, d):
    return ringed(spark, d).groupBy("ring").agg(F.sum("population").alias("population"), F.count("*").alias("cells"))


# A concave outline; all but its fourth corner are corners of its hull.
OUTLINE = [(-71.2031, 42.1967), (-71.1263, 42.2011), (-71.1312, 42.2717), (-71.1644, 42.2313), (-71.1987, 42.2689)]


def _sides(corners) -> str:
    return "(VALUES " + ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(corners, corners[1:] + corners[:1])) + ") AS s(px, py, qx, qy)"


# A segment and a box lie apart if their bounds do or all corners are on one side of its line.
_SIDE = "(qx - px) * ({1} - py) - (qy - py) * ({0} - px)"
_SIDES = ", ".join(_SIDE.format(x, y) for x in ("minx", "maxx") for y in ("miny", "maxy"))
_MEET = f"least(px, qx) <= maxx AND greatest(px, qx) >= minx AND least(py, qy) <= maxy AND greatest(py, qy) >= miny AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0"
_HELD = "count(*) FILTER ((py > cy) <> (qy > cy) AND cx < (qx - px) * (cy - py) / (qy - py) + px) % 2 = 1"
G09_SQL = f"""WITH b AS (SELECT *, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM boxes),
    met AS (SELECT idx, bool_or({_MEET}) OR {_HELD} AS met FROM b CROSS JOIN {_sides(OUTLINE)} GROUP BY idx),
    crossed AS (SELECT idx, bool_or({_MEET.replace("<=", "<").replace(">=", ">")}) AS crossed FROM b CROSS JOIN {_sides(OUTLINE[:3] + OUTLINE[4:])} GROUP BY idx)
    SELECT idx, CASE WHEN met THEN 'inside' ELSE 'outside' END AS position, CASE WHEN crossed THEN 'edge' ELSE 'none' END AS relation_to_line FROM met JOIN crossed USING (idx)"""


@query("g09_boundary_class", G09_SQL)
def g09(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in OUTLINE])
    outline = spark.range(1).select(F.col("id").alias("polygon"), ring.alias("ring"))
    return polygons.boundary_class(view(spark, d, "boxes"), outline, SIZE).select("idx", "position", "relation_to_line")


@query("g10_convex_hull")
def g10(spark, d):
    return tiling.convex_hull(view(spark, d, "nodes").withColumn("g", F.col("index") % 3), "g")


@query("g12_density", "SELECT idx, round(population / ((6e4::double * (1.85533::double - 0.006222::double * sin(radians(miny)))) * cos(radians(miny)) * (maxx - minx) * (6e4::double * (1.85533::double - 0.006222::double * sin(radians(miny)))) * (maxy - miny) / 1e6::double), 4) AS density FROM boxes")
def g12(spark, d):
    return view(spark, d, "boxes").select("idx", F.round(F.try_divide(F.col("population").cast("double"), tiling.cell_area_km2("minx", "miny", "maxx", "maxy")), 4).alias("density"))


def _refined(size: float, n: int) -> str:
    fx, fy = f"round((x + 71.21::double) / {size}::double, 9)", f"round((y - 42.19::double) / {size}::double, 9)"
    return f"SELECT {size}::double AS size, cast(floor({fx}) * {n} + floor({fy}) AS BIGINT) AS cell FROM nodes WHERE x > -71.21 AND x < -71.11 AND y > 42.19 AND y < 42.29 AND {fx} <> floor({fx}) AND {fy} <> floor({fy})"


@query("g13_refine_tiling", f"SELECT size, cell, count(*) AS n FROM ({_refined(0.02, 5)} UNION ALL {_refined(0.01, 10)}) GROUP BY size, cell")
def g13(spark, d):
    return tiling.refine(view(spark, d, "nodes"), BOX, [0.02, 0.01])


METRES = "6e4::double * (1.85533::double - 0.006222::double * sin(radians(42.19::double)))"
G14_SQL = f"""WITH part AS (SELECT idx // 6 AS component, {METRES} * cos(radians(42.19::double)) * (minx + 71.21::double) AS x0, {METRES} * cos(radians(42.19::double)) * (maxx + 71.21::double) AS x1,
    {METRES} * (miny - 42.19::double) AS y0, {METRES} * (maxy - 42.19::double) AS y1 FROM boxes WHERE idx % 6 = 1),
    ext AS (SELECT min(x0) AS x, min(y0) AS y, cast(ceil((max(x1) - min(x0)) / 500) AS BIGINT) AS nx, cast(ceil((max(y1) - min(y0)) / 500) AS BIGINT) AS ny FROM part),
    sq AS (SELECT component, i, j, x + i * 500 AS x, y + j * 500 AS y, nx * ny * component * component AS shift FROM part, ext, (SELECT unnest(range(100)) AS i) a, (SELECT unnest(range(100)) AS j) b WHERE i < nx AND j < ny)
    SELECT component, i + shift AS i, j + shift AS j, EXISTS (SELECT 1 FROM part p WHERE sq.x >= p.x0 AND sq.x + 500 <= p.x1 AND sq.y >= p.y0 AND sq.y + 500 <= p.y1) AS inside FROM sq"""


@query("g14_metric_grid", G14_SQL)
def g14(spark, d):
    metre = lambda x, y: F.struct(*[c.alias(k) for k, c in zip("xy", tiling.tangent_xy(F.col(y), F.col(x), F.lit(42.19), F.lit(-71.21)))])
    ring = F.array(metre("minx", "miny"), metre("maxx", "miny"), metre("maxx", "maxy"), metre("minx", "maxy"))
    shapes = view(spark, d, "boxes").filter("idx % 6 = 1").select(F.expr("idx div 6").alias("component"), ring.alias("ring"))
    return tiling.metric_grid(shapes, 500.0).select("component", "i", "j", "inside")


@query("g15_zonal_sum", f"SELECT cell, cast(sum(greatest(index % 11 - 3, 0)) AS BIGINT) AS value FROM ({LOCATED}) WHERE cell IS NOT NULL GROUP BY cell")
def g15(spark, d):
    return tiling.zonal_sum(view(spark, d, "nodes").select("x", "y", (F.col("index") % 11 - 3).alias("value")), BOX, SIZE)


@query("j12_overlap", """SELECT t.idx, round(sum(s.population * greatest(least(s.maxx, t.maxx) - greatest(s.minx, t.minx), 0) * greatest(least(s.maxy, t.maxy) - greatest(s.miny, t.miny), 0) / ((s.maxx - s.minx) * (s.maxy - s.miny))), 4) AS population
    FROM boxes t JOIN (SELECT idx, minx + 0.007 AS minx, maxx + 0.007 AS maxx, miny + 0.004 AS miny, maxy + 0.004 AS maxy, population FROM boxes) s ON s.minx < t.maxx AND s.maxx > t.minx AND s.miny < t.maxy AND s.maxy > t.miny GROUP BY t.idx""")
def j12(spark, d):
    b = view(spark, d, "boxes")
    s = b.withColumns({c: F.col(c) + v for c, v in (("minx", 0.007), ("maxx", 0.007), ("miny", 0.004), ("maxy", 0.004))})
    return tiling.area_overlap(s, b, SIZE).select("idx", F.round("population", 4).alias("population"))


# Hexagons of radius 0.013 with corners to the left and right; the width at a height falls from twice to once the radius. The shared area is
# the width's integral over the height, and between the heights where it changes its course it is a trapezoid.
_R, _H = "0.013::double", "(0.013::double * sqrt(3) / 2)"
_HALF = f"({_R} - abs(y - hy) / {_H} * {_R} / 2)"
_TURNS = ", ".join(["lo", "hi", "hy", *[f"hy {s} {d} * 2 * {_H} / {_R}" for s in "+-" for e in ("minx", "maxx") for d in (f"(hx + {_R} - {e})", f"({e} - hx + {_R})")]])
HEX_SQL = f"""WITH h AS (SELECT idx AS source, (minx + maxx) / 2 + 0.0071 AS hx, (miny + maxy) / 2 + 0.0043 AS hy, population AS people FROM boxes),
    pair AS (SELECT idx, source, people, hx, hy, minx, maxx, greatest(miny, hy - {_H}) AS lo, least(maxy, hy + {_H}) AS hi FROM boxes JOIN h ON h.hx - {_R} < maxx AND h.hx + {_R} > minx AND h.hy - {_H} < maxy AND h.hy + {_H} > miny),
    turn AS (SELECT *, unnest([{_TURNS}]) AS raw FROM pair),
    height AS (SELECT DISTINCT * EXCLUDE (raw), least(greatest(raw, lo), hi) AS y FROM turn),
    width AS (SELECT *, greatest(least(hx + {_HALF}, maxx) - greatest(hx - {_HALF}, minx), 0) AS w FROM height),
    slab AS (SELECT *, (y - lag(y) OVER p) * (w + lag(w) OVER p) / 2 AS area FROM width WINDOW p AS (PARTITION BY idx, source ORDER BY y))
    SELECT idx, round(sum(people * area) / (1.5::double * sqrt(3) * {_R} * {_R}), 4) AS population FROM slab WHERE people > 0 GROUP BY idx HAVING sum(area) > 1e-12"""


def hexagons(boxes, radius: float):
    """The boxes' centres, moved a little, as hexagons."""
    x, y = (F.col("minx") + F.col("maxx")) / 2 + 0.0071, (F.col("miny") + F.col("maxy")) / 2 + 0.0043
    turns = [(1.0, 0.0), (0.5, 0.75**0.5), (-0.5, 0.75**0.5), (-1.0, 0.0), (-0.5, -(0.75**0.5)), (0.5, -(0.75**0.5))]
    return boxes.select("idx", "population", F.array(*[F.struct((x + radius * a).alias("x"), (y + radius * b).alias("y")) for a, b in turns]).alias("ring"))


@query("j12_hexagons", HEX_SQL)
def j12_hexagons(spark, d):
    b = view(spark, d, "boxes")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    tracts = b.select("idx", F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy")).alias("ring"))
    return rounded(polygons.polygon_overlap(hexagons(b, 0.013), tracts, SIZE), 4)


@query("j11_point_in_polygon", "SELECT index, idx AS polygon FROM (SELECT index, x + 0.00003::double AS px, y + 0.00005::double AS py FROM nodes) n JOIN boxes ON px - minx + py - miny < 0.02 AND px > minx AND py > miny")
def j11(spark, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    triangles = view(spark, d, "boxes").select(F.col("idx").alias("polygon"), F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("minx", "maxy")).alias("ring"))
    # moved off the triangles' edges
    n = view(spark, d, "nodes").select("index", (F.col("x") + 0.00003).alias("x"), (F.col("y") + 0.00005).alias("y"))
    return polygons.point_in_polygon(n, triangles, SIZE).select("index", "polygon")


@query("m10_polar", "SELECT idx, round(sqrt(pow(cx + 71.161::double, 2) + pow(cy - 42.241::double, 2)), 9) AS r, round(atan((cy - 42.241::double) / (cx + 71.161::double)), 6) AS theta FROM cells")
def m10(spark, d):
    out = tiling.polar(view(spark, d, "cells"), (-71.161, 42.241))
    return out.select("idx", F.round("r", 9).alias("r"), F.round("theta", 6).alias("theta"))


def _hist_sql(source: str, column: str, bins: int, weight: str = "1") -> str:
    return f"""WITH v AS (SELECT cast({column} AS DOUBLE) AS v, {weight} AS x FROM {source}), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM v),
        c AS (SELECT least(cast(floor(round(v - lo, 9) / w) AS BIGINT), {bins - 1}) AS bin, sum(x) AS n FROM v, e GROUP BY 1)
        SELECT s.bin, round(lo + s.bin * w, 6) AS low, round(lo + (s.bin + 1) * w, 6) AS high, cast(coalesce(n, 0) AS DOUBLE) AS n FROM (SELECT cast(unnest(range({bins})) AS BIGINT) AS bin) s CROSS JOIN e LEFT JOIN c ON c.bin = s.bin"""


for _n, _source, _column, _bins in (("a06_hist_distance", "people", "distance", 100), ("a06_hist_capacity", "edges", "capacity", 25), ("a06_hist_departure", "people", "time_departure", 24), ("a06_hist_flows", "tij", "number_people", 100), ("a06_hist_population", "cells", "population", 40)):
    query(_n, _hist_sql(_source, _column, _bins))(lambda spark, d, s=_source, c=_column, b=_bins: rounded(hist.histogram(view(spark, d, s), c, b)))


@query("a26_weighted_distance_hist", _hist_sql("(SELECT distance, number_people FROM tij JOIN pairs ON origin = i AND destination = j)", "distance", 50, "number_people"))
def a26(spark, d):
    p = tiling.cell_pairs(view(spark, d, "cells")).withColumn("distance", F.round("distance", 9))
    t = view(spark, d, "tij").join(p.withColumnsRenamed({"i": "origin", "j": "destination"}), ["origin", "destination"])
    return rounded(hist.histogram(t, "distance", 50, "number_people"))


@query("j14_flow_distance", "SELECT origin, destination, number_people, round(distance, 6) AS distance FROM tij JOIN pairs ON origin = i AND destination = j")
def j14(spark, d):
    p = tiling.cell_pairs(view(spark, d, "cells")).withColumnsRenamed({"i": "origin", "j": "destination"})
    return rounded(view(spark, d, "tij").join(p, ["origin", "destination"]).select("origin", "destination", "number_people", "distance"))


@query("p30_conditional_view", _hist_sql("(SELECT distance FROM people WHERE num_steps > 600)", "distance", 20))
def p30(spark, d):
    return rounded(hist.histogram(view(spark, d, "people").filter("num_steps > 600"), "distance", 20))


H = _hist_sql("people", "distance", 100)


@query("p27_cumulative_share", f"SELECT bin, n FROM (SELECT bin, n, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM ({H})) WHERE b < 0.9 * t".replace("FROM people", "FROM people"))
def p27(spark, d):
    return hist.cumulative_share(hist.histogram(view(spark, d, "people"), "distance", 100), 0.9).select("bin", "n")


@query("w09_fill_empty_bins", f"SELECT bin, round(coalesce(f, a + (b - a) * (bin - ka) / nullif(kb - ka, 0), a, b), 6) AS n FROM (SELECT bin, CASE WHEN n > 0 THEN n END AS f, last_value(CASE WHEN n > 0 THEN n END IGNORE NULLS) OVER p AS a, last_value(CASE WHEN n > 0 THEN bin END IGNORE NULLS) OVER p AS ka, first_value(CASE WHEN n > 0 THEN n END IGNORE NULLS) OVER q AS b, first_value(CASE WHEN n > 0 THEN bin END IGNORE NULLS) OVER q AS kb FROM ({H}) WINDOW p AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
def w09(spark, d):
    return rounded(hist.fill_empty_bins(hist.histogram(view(spark, d, "people"), "distance", 100)).select("bin", "n"))


@query("a11_exceedance", "SELECT g AS gamma, cast(coalesce(sum(number_people) FILTER (number_people > g), 0) AS BIGINT) AS total, count(*) FILTER (number_people > g) AS count, round(count(*) FILTER (number_people > g) / count(*), 9) AS fraction FROM tij CROSS JOIN (SELECT unnest([20.0, 50.0, 100.0])::DOUBLE AS g) GROUP BY g")
def a11(spark, d):
    return rounded(hist.exceedance(view(spark, d, "tij"), "number_people", [20, 50, 100]), 9)


@query("w08_thin", """WITH RECURSIVE v AS (SELECT DISTINCT l_discount AS x FROM lineitem), k AS (SELECT min(x) AS x FROM v UNION ALL SELECT (SELECT min(v.x) FROM v WHERE round(v.x - k.x, 12) > 0.015) FROM k WHERE k.x IS NOT NULL) SELECT x FROM k WHERE x IS NOT NULL""")
def w08(spark, d):
    from flowgrid.plans.views import table

    return hist.thin_by_gap(table(spark, d, "lineitem").select(F.col("l_discount").alias("x")), "x", 0.015)


@query("s07_read_cell_pairs", "SELECT i, j, round(dx, 6) AS x, round(dy, 6) AS y, round(distance, 6) AS distance FROM pairs")
def s07(spark, d):
    from flowgrid.sources import files

    p = tiling.cell_pairs(view(spark, d, "cells")).select("i", "j", F.col("dx").alias("x"), F.col("dy").alias("y"), "distance")
    return rounded(files.stored_and_read(p, files.write_cell_pairs, files.read_cell_pairs))


@query("s08_read_cells", "SELECT idx, population, round(minx, 6) AS minx, round(miny, 6) AS miny, round(maxx, 6) AS maxx, round(maxy, 6) AS maxy FROM boxes")
def s08(spark, d):
    from flowgrid.sources import files

    return rounded(files.stored_and_read(view(spark, d, "boxes"), files.write_cells, files.read_cells))


@query("m03_parse_vector", "SELECT i, j, round(dx, 6) AS x, round(dy, 6) AS y FROM pairs")
def m03(spark, d):
    from flowgrid.sources.files import parse_vector

    p = tiling.cell_pairs(view(spark, d, "cells"))
    return rounded(p.select("i", "j", *parse_vector(F.concat(F.lit("["), F.col("dx").cast("string"), F.lit(", "), F.col("dy").cast("string"), F.lit("]")))))


@query("m04_seconds_to_hms", "SELECT p, strftime(to_timestamp(time_departure) AT TIME ZONE 'UTC', '%H:%M:%S') AS hms FROM people")
def m04(spark, d):
    return view(spark, d, "people").select("p", F.date_format(F.timestamp_seconds("time_departure"), "HH:mm:ss").alias("hms"))


@query("m05_minutes_to_ts", "SELECT p, (time_departure // 60) * 60 + 7 * 3600 + 1704067200 AS at FROM people")
def m05(spark, d):
    ts = F.timestamp_seconds(F.lit(1704067200) + 7 * 3600 + F.floor(F.col("time_departure") / F.lit(60.0)) * 60)
    return view(spark, d, "people").select("p", F.unix_timestamp(ts).alias("at"))


@query("m16_free_flow_time", "SELECT uniqueid, round(length / (speed_mph * 1.6::double / 3.6::double), 6) AS seconds FROM edges")
def m16(spark, d):
    return rounded(trajectory.convert_units(view(spark, d, "edges")).select("uniqueid", (F.col("length") / F.col("mps")).alias("seconds")))


@query("m15_morlet", "SELECT p, round(exp(-x * x / 2) * cos(2 * pi() * x / 2.5::double), 9) AS y FROM (SELECT p, (time_departure - 27000) / 3600.0::double AS x FROM people)")
def m15(spark, d):
    from flowgrid.functions.curves import morlet

    return view(spark, d, "people").select("p", F.round(morlet((F.col("time_departure") - 27000) / F.lit(3600.0), 2.5), 9).alias("y"))
