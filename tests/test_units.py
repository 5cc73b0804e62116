"""Hand-made rows, one case after another."""

import math

from pyspark.sql import functions as F

from flowgrid.operators import centrality, demand, field, fits, gravity, hist, networks, roads, slices, tiling, trajectory
from flowgrid.operators.components import components


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_valid_trips_keeps_one_of_three(spark):
    people = spark.createDataFrame([(1, 100.0, 0), (2, 16000.0, 360), (3, 1000.0, 100)], "p long, distance double, num_steps long")
    assert [r.p for r in trajectory.valid_trips(people).collect()] == [3]


def test_route_text_drops_empty_items(spark):
    r = spark.createDataFrame([(1, "[5,,7,]"), (2, "[]"), (3, None)], "p long, route string")
    assert rows(trajectory.explode_routes(r)) == [(1, 0, 5), (1, 1, 7)]


def test_laws_are_told_apart(spark):
    x = [(k / 4) for k in range(1, 60)]
    points = [(1, t, 100 * math.exp(-t / 2)) for t in x] + [(2, t, 100 * t**-1.5) for t in x]
    out = {r.g: r for r in fits.compare_pl_exp(spark.createDataFrame(points, "g long, x double, y double"), ["g"]).collect()}
    assert out[1].err_exp < out[1].err_pl and abs(out[1].alpha_exp + 0.5) < 1e-9
    assert out[2].err_pl < out[2].err_exp and abs(out[2].alpha_pl + 1.5) < 1e-9


def test_bins_follow_truncated_instants(spark):
    limits = [int(k * 86400 / 95) for k in range(96)]
    got = spark.range(86400).select("id", slices.bin_of(F.col("id")).alias("k")).collect()
    import bisect

    assert all(r.k == bisect.bisect_right(limits, r.id) - 1 for r in got)


def test_lattice_potential_follows_column_then_row(spark):
    cells = spark.createDataFrame([(i * 2 + j, i, j) for i in range(2) for j in range(2)], "idx long, i long, j long")
    edges = spark.createDataFrame([(0, 1, "j", 1.0, 2.0, 1.0, 0.5), (0, 2, "i", 3.0, 4.0, 1 / 3, 0.25), (1, 3, "i", 1.0, 1.0, 1.0, 1.0), (2, 3, "j", 5.0, 6.0, 0.2, 1 / 6)], "a long, b long, way string, dx double, dy double, inv_dx double, inv_dy double")
    f = spark.createDataFrame([(k, 1.0, 1.0) for k in range(4)], "idx long, out_x double, out_y double")
    assert rows(field.lattice_potential(f, cells, edges)) == [(0, 0.0), (1, 3.0), (2, 7.0), (3, 18.0)]


def test_lorenz_index_of_equal_and_dominant_cells(spark):
    same = spark.createDataFrame([(k, 7.0) for k in range(5)], "idx long, v double")
    one = spark.createDataFrame([(k, 100.0 if k == 0 else 0.0) for k in range(5)], "idx long, v double")
    assert centrality.lorenz_index(same, "v").first().f_star == 1
    assert centrality.lorenz_index(one, "v").first().f_star == 5


def test_quarter_overlap_moves_a_quarter(spark):
    box = "idx long, minx double, miny double, maxx double, maxy double, population long"
    a, b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 100)], box), spark.createDataFrame([(9, 0.5, 0.5, 1.5, 1.5, 0)], box)
    assert rows(tiling.area_overlap(a, b, 1.0)) == [(9, 25.0)]


def test_components_of_triangle_and_edge(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9), (9, 8), (5, 5), (None, 4)], "u long, v long")
    sizes = sorted(r["count"] for r in components(e).groupBy("component").count().collect())
    assert sizes == [1, 2, 3]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)], "u long, v long")
    assert components(e).select("component").distinct().count() == 2


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "u long, v long")
    assert rows(networks.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_ratio_at_the_limit_is_not_moderate(spark):
    s = spark.createDataFrame([(1, 0, 5, 16.0)], "route long, k long, flux long, speed_kmh double")
    e = spark.createDataFrame([(1, 1, 2, 20)], "uniqueid long, u long, v long, speed_mph long")
    r = slices.traffic_classes(s, e).first()
    assert not r.moderate and r.free_flow


def test_departures_are_spread_over_the_hour(spark):
    od = spark.createDataFrame([(0, 1, 3), (0, 2, 0), (1, 0, 2)], "origin long, destination long, n long")
    got = rows(demand.expand_persons(od, F.lit(7)), "person")
    assert [(r[0], r[4]) for r in got] == [(0, 25200.0), (1, 26400.0), (2, 27600.0), (3, 25200.0), (4, 27000.0)]


def test_thinning_by_gap(spark):
    v = spark.createDataFrame([(0.0,), (0.005,), (0.010,), (0.0105,)], "x double")
    assert rows(hist.thin_by_gap(v, "x", 0.009)) == [(0.0,), (0.010,)]


def test_gravity_parameters_come_back(spark):
    import itertools

    data = [(a, b, math.exp(-2) * m**0.8 * n**0.6 * math.exp(-0.05 * d), float(m), float(n), d) for a, (m, n, d) in enumerate(itertools.product((10, 50, 300), (20, 90, 500), (1.0, 5.0, 11.0))) for b in (0,)]
    p = gravity.gravity_fit(spark.createDataFrame(data, "origin long, destination long, w double, mi double, mj double, d double")).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip((p.logk, p.alpha, p.gamma, p.inverse_d0), (-2, 0.8, 0.6, -0.05)))


def test_histogram_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [r.n for r in hist.histogram(one, "x", 3).orderBy("bin").collect()] == [2.0, 0.0, 0.0]
    assert sum(r.n for r in hist.histogram(one.limit(0), "x", 3).collect()) == 0


def test_raw_speeds(spark):
    raw = spark.createDataFrame([("35 mph",), ('["30 mph", "40 mph"]',), ("signals",), (None,), ("35;45",)], "s string")
    assert [r[0] for r in raw.select(roads.parse_maxspeed(F.col("s"))).collect()] == [35.0, 35.0, 10.0, None, 40.0]


def test_shares_sum_and_flows_rescale(spark):
    cells = spark.createDataFrame([(0, 100), (1, 50), (2, 0)], "idx long, population long")
    pairs = spark.createDataFrame([(a, b, float(abs(a - b))) for a in range(3) for b in range(3)], "i long, j long, distance double")
    out = gravity.gravity_flows(cells, pairs, 1.0, 1.0, 1.0, -0.1, 500.0)
    assert abs(out.agg(F.sum("people")).first()[0] - 500) < 1e-9
    assert out.filter("origin = 2").agg(F.sum("people")).first()[0] == 0


def test_hull_of_square_with_inner_points(spark):
    pts = spark.createDataFrame([(1, x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5), (0.5, 0.0))], "g long, x double, y double")
    assert {(r.x, r.y) for r in tiling.convex_hull(pts, "g").collect()} == {(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)}
